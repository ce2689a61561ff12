"""Queries of this subpackage's operators, as `__spark_entry__.py` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

RANKS, TOKENIZER, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens of the byte vocabulary."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path(TOKENIZER))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_stream import add_stream, read_streams

    return read_streams(add_stream(table(spark, sf_dir, "documents")))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_encoding import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tree_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_trees import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lattice_model import score_texts

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_models import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .web_archive import capture_digests

    return capture_digests(table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_media_columns": op3_media_columns,
        "op4_piece_encoding": op4_piece_encoding,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_url_filters": op8_url_filters,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_html_extraction": op10_html_extraction,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_warc": op12_warc,
        "op13_collocations": op13_collocations,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingle sets, their classes by equal sets, links of classes and components by reachability.
SIMILAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(l, i, i + 4), ' ') AS shingle FROM w, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS t(i) WHERE len(l) > 0),
sized AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, '|' ORDER BY shingle)) AS class FROM s GROUP BY 1),
reps AS (SELECT class, min(doc_id) AS doc_id, any_value(n) AS n FROM sized GROUP BY 1),
r AS (SELECT doc_id, shingle FROM s SEMI JOIN reps USING (doc_id)),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM r a JOIN r b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM met JOIN reps p ON p.doc_id = x JOIN reps q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT doc_id AS o, doc_id AS n FROM reps UNION SELECT reach.o, e.y FROM reach JOIN edges e ON e.x = reach.n),
least AS (SELECT n, min(o) AS component FROM reach GROUP BY 1),
degree AS (SELECT x, count(*) AS links FROM edges GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(links, 0) AS n_links FROM documents d LEFT JOIN sized z ON z.doc_id = d.doc_id LEFT JOIN reps ON reps.class = z.class
LEFT JOIN least ON least.n = reps.doc_id LEFT JOIN degree ON degree.x = reps.doc_id"""


#: CRC32 bit by bit, words as the contract rewrites them, equal words at every distance q, their stretches, and of equal stretches the least q.
RUNS = """WITH RECURSIVE step AS (SELECT doc_id, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents)
UNION ALL SELECT doc_id, k + 1, CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END
FROM (SELECT doc_id, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE c END AS y FROM step WHERE k < 8 * length(doc_id::VARCHAR))),
hashed AS (SELECT doc_id, xor(c, 4294967295) AS h FROM step WHERE k = 8 * length(doc_id::VARCHAR)),
raw AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents JOIN hashed USING (doc_id)),
cut AS (SELECT *, len(l) AS n, CASE WHEN h % 10 = 0 AND len(l) > 0 THEN g % len(l) ELSE len(l) END AS a FROM raw),
w AS (SELECT doc_id, i, l[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word, n FROM cut, unnest(range(n)) AS t(i)),
met AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM met) GROUP BY doc_id, q, grp HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) AS place FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN ranked r ON r.doc_id = d.doc_id AND place = 1"""


#: Payload digests, the newest page of equal payloads, and places by key of the url, time and page.
CAPTURES = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN trim(coalesce(url, '')) = '' THEN 'about:blank' ELSE url END AS url FROM pages),
k AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, (page_id % 4000000000) * 1000000 AS captured, strpos(url, '://') AS cut, url, split_part(substr(url, strpos(url, '://') + 3), '#', 1) AS rest FROM p),
h AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM k),
u AS (SELECT *, CASE WHEN cut = 0 THEN ')' || url ELSE array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || substr(rest, length(host) + 1) END AS url_key, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND newest > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND newest > page_id THEN newest END AS refers_to,
url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) AS place FROM u"""


#: All phrases of 1 to 4 words of pieces, candidates, their cuts, and candidates inside longer ones.
PHRASES = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM t),
g AS (SELECT lang, m, array_to_string(list_slice(l, i, i + m - 1), ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, 5)) AS u(m), unnest(range(1, greatest(len(l) - m + 1, 0) + 1)) AS v(i) GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS l FROM g WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.m, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score FROM c, unnest(range(1, c.m)) AS u(k)
JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.l, 1, k), ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.l, k + 1, c.m), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(list_slice(l, i, i + s - 1), ' ') AS phrase, max(f) AS top FROM c, unnest(range(2, c.m)) AS u(s), unnest(range(1, c.m - s + 2)) AS v(i) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE top IS NULL OR 100 * top < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": SIMILAR, "op11_periodic_runs": RUNS, "op12_warc": CAPTURES, "op13_collocations": PHRASES}
