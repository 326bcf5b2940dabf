"""Queries of the operators on runs, prefixes and URLs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs, prefix_trie, url_filters
from tidemark.llm.hot import most_of, spread_join
from tidemark.llm.storage import written
from tidemark.llm.tokens import WORD

_UPPER, _LOWER = url_filters.UPPER, url_filters.LOWER


def _crc(value: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a decimal number: bit by bit with the reflected polynomial."""
    step = "list_reduce([a.a] || range(8), lambda x, k: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    each = step.replace("a.a", "xor(a, b)")
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(({value})::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: {each}), 4294967295)"


def rebuilt_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose crc32(doc_id) ends in 0 made periodic from one of their words on, the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.col("g") % F.nullif(F.col("n"), F.lit(0))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", source(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the rebuilt documents; a null doc_id leaves its text as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs.periodic_runs(rebuilt_texts(docs)).withColumn("top", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


#: All pairs of places of one text that start the same 16 words; their stretches on one lag, smallest lag first.
OP11_SQL = rf"""
WITH w AS (
  SELECT doc_id, {_crc("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w
), g AS (
  SELECT doc_id, ws, a, 1 + (len(ws) - a) // (3 + (h // 10) % 8) AS p FROM f
), d AS (
  SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(len(ws)), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM g
), s AS (
  SELECT doc_id, len(ws) AS n, i, array_to_string(ws[i + 1:i + 16], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(len(ws) - 15)) AS i FROM d WHERE len(ws) >= 24)
), q AS (
  SELECT x.doc_id, y.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.seq = y.seq AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), k AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM q
), m AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + 15 + q AS length FROM k GROUP BY doc_id, q, stretch
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM m WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
), o AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id
), t AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
), e AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), c AS (
  SELECT b.doc_id, string_agg(b.word, ' ' ORDER BY b.i) AS text
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d) b LEFT JOIN e ON e.doc_id = b.doc_id AND e.i = b.i
  WHERE e.i IS NULL GROUP BY b.doc_id
)
SELECT x.doc_id, coalesce(o.n_runs, 0) AS n_runs, t.start, t.length, t.period, 1000 * t.length // t.period AS exponent_milli,
       sha256(coalesce(o.lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents x LEFT JOIN o ON o.doc_id = x.doc_id LEFT JOIN t ON t.doc_id = x.doc_id LEFT JOIN c ON c.doc_id = x.doc_id
"""

_LARGEST_HEAD = 5


def rebuilt_turns(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, position, key, size): each conversation with its first crc32 % 6 turns from the one that leads its hundred."""
    base = F.col("conv_id") - F.col("conv_id") % 100
    first = turns.where((F.col("conv_id") % 100 == 0) & (F.col("position") < _LARGEST_HEAD))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("position", "key", "size"))).alias("head"))
    plan = ids.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int").alias("h")).join(heads, "base", "left")
    given = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<position: bigint, key: binary, size: bigint>>"))
    plan = written(plan.select("conv_id", "h", given.alias("given")), "rebuilding")
    most, n = most_of(turns, "conv_id")
    own = spread_join(turns, plan.select("conv_id", "h", F.size("given").alias("m")), ["conv_id"], "key", most, n).where("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("m")).alias("position"), "key", "size")
    return own.unionByName(plan.select("conv_id", F.explode("given").alias("t")).select("conv_id", "t.position", "t.key", "t.size"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations; rows without conv_id belong to none."""
    turns = prefix_trie.keyed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    ids = turns.select("conv_id").distinct()
    return prefix_trie.prefix_trie(rebuilt_turns(turns, ids), ids)


OP12_SQL = f"""
WITH k AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key) AS ks, list(size ORDER BY turn NULLS FIRST, key) AS ss FROM k GROUP BY conv_id
), h AS (
  SELECT *, ({_crc("conv_id")} % 6)::BIGINT AS h FROM c
), b AS (
  SELECT h.conv_id, coalesce(x.ks[1:h.h], []) || h.ks[h.h + 1:] AS ks, coalesce(x.ss[1:h.h], []) || h.ss[h.h + 1:] AS ss
  FROM h LEFT JOIN c x ON x.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, d, len(ks) = d AS ends, array_to_string(ks[1:d], '') AS pre, CASE WHEN d > 0 THEN ss[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM b)
), n AS (
  SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) * (count(*) - 1) AS saved, count(*) FILTER (WHERE ends) = count(*) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY d, pre
), s AS (
  SELECT a.d, a.pre, count(*) FILTER (WHERE b.leaf) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE b.d = a.d + 1) AS n_children
  FROM n a JOIN n b ON b.d >= a.d AND left(b.pre, 64 * a.d) = a.pre GROUP BY a.d, a.pre
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.d = n.d AND s.pre = n.pre LEFT JOIN n u ON u.d = n.d - 1 AND u.pre = left(n.pre, 64 * (n.d - 1))
"""

#: Fixed values of the contract of op13.
URL_RULES = (
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the listed rules, and where none fits by rules mined from the URLs that one fits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "mined")


def _words(part: str, k: int) -> str:
    spelt = rf"string_split_regex(translate(coalesce(regexp_extract(url, '{url_filters.PARTS}', {k}), ''), '{_UPPER}', '{_LOWER}'), '{url_filters.PUNCTUATION}')"
    return f"list_transform(list_filter({spelt}, lambda w: w <> ''), lambda w: '{part}:' || CASE WHEN regexp_full_match(w, '[0-9]+') THEN '#' ELSE w END)"


def _fits(rule: url_filters.Rule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r.text))

#: Every set of frequent tokens of every listed URL is counted; the best of the sure ones that a URL holds decides.
OP13_SQL = rf"""
WITH u AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_distinct({" || ".join(_words(part, k) for k, part in enumerate("shpqf", 1))})) AS tokens
  FROM pages
), l AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _BY_LENGTH)} END AS rule,
         CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _BY_LENGTH)} END AS listed
  FROM u
), n AS (
  SELECT count(*) AS n, ceil({url_filters.MIN_SUPPORT} * count(*)) AS least FROM l WHERE listed IS NOT NULL
), f AS (
  SELECT token FROM (SELECT unnest(tokens) AS token FROM l WHERE listed IS NOT NULL) GROUP BY token HAVING count(*) >= (SELECT least FROM n)
), v AS (
  SELECT list(token) AS known FROM f
), b AS (
  SELECT l.page_id, l.listed, list_filter(l.tokens, lambda t: list_contains(v.known, t)) AS ts FROM l, v
), x AS (
  SELECT listed, unnest(list_transform(range(1, (1::BIGINT << len(ts))), lambda mask: array_to_string(list_filter(ts, lambda t, i: (mask >> (i - 1)) & 1 = 1), ' '))) AS s FROM b WHERE listed IS NOT NULL
), c AS (
  SELECT s, listed, count(*) AS k, sum(count(*)) OVER (PARTITION BY s) AS total FROM x GROUP BY s, listed
), r AS (
  SELECT s, listed, k / total AS confidence, k FROM c, n WHERE k >= n.least AND k / total >= {url_filters.MIN_CONFIDENCE}
), m AS (
  SELECT page_id, unnest(list_transform(range(1, (1::BIGINT << len(ts))), lambda mask: array_to_string(list_filter(ts, lambda t, i: (mask >> (i - 1)) & 1 = 1), ' '))) AS s FROM b WHERE listed IS NULL
), g AS (
  SELECT m.page_id, r.listed, r.s FROM m JOIN r ON r.s = m.s
  QUALIFY row_number() OVER (PARTITION BY m.page_id ORDER BY r.confidence DESC, r.k DESC, len(string_split(r.s, ' ')), r.s, r.listed) = 1
)
SELECT l.page_id, l.host, l.path, l.rule, coalesce(l.listed, g.listed, 'allow') AS verdict, g.s AS mined FROM l LEFT JOIN g ON g.page_id = l.page_id
"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs, "op12_prefix_trie": op12_prefix_trie, "op13_url_filters": op13_url_filters}
ORACLES = {"op11_periodic_runs": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_url_filters": OP13_SQL}
