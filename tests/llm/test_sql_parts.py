"""The columns of corpus queries that SQL can express, where it can't express the whole row: base secrets, base scores, sizes and targets, edited texts."""

import duckdb
import pytest

from tidemark.llm import queries
from tidemark.llm.more_queries import _crc

WORDS = r"'[^\x20\x09-\x0D]+'"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text, source FROM '{sf_dir}/documents.parquet'")
    return con


def compared(spark, sf_dir, duck, query, sql, columns, digits=6):
    got = sorted(tuple(round(r[c], digits) if isinstance(r[c], float) else r[c] for c in columns) for r in query(spark, sf_dir).collect())
    want = sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in row) for row in duck.execute(sql).fetchall())
    assert len(got) == len(want) > 100
    for a, b in zip(got, want):
        assert a == tuple(pytest.approx(x, rel=1e-9, abs=10.0**-digits) if isinstance(x, float) else x for x in b)


def test_op10_edited_texts(spark, sf_dir, duck):
    sql = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first(coalesce(text, '')) OVER w) AS following
               FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 3) || left(following, length(text) // 3)) AS edited_sha256 FROM d
    """
    compared(spark, sf_dir, duck, queries.op10_fingerprint, sql, ["doc_id", "n_chars", "edited_sha256"])


def test_op8_base_scores(spark, sf_dir, duck):
    sql = f"""
    WITH d AS (SELECT doc_id, {_crc("doc_id")} % 5 = 1 AS held_out,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) || [''] AS ts FROM documents)
    , t AS (SELECT doc_id, held_out, unnest(ts) AS token FROM d)
    , c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token)
    , n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, max(n.n)::BIGINT AS train_tokens, sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))) AS base_score
    FROM t LEFT JOIN c USING (token), n GROUP BY doc_id, held_out
    """
    compared(spark, sf_dir, duck, queries.op8_hmm_scores, sql, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])


def test_op3_sizes_and_targets(spark, sf_dir, duck):
    """Sources that reach twice their size leave; the others share what is left, until none is above."""
    rows = duck.execute(f"SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS size FROM documents").fetchall()
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_sources = {}, 1.5 * sum(sizes.values()), set(order)
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_sources}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_sources -= full
    got = {r.doc_id: r for r in queries.op3_mixing(spark, sf_dir).collect()}
    taken = {}
    for doc_id, source, size in rows:
        r = got[doc_id]
        assert (r.size, r.source_size) == (size, sizes[source]) and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * size
        taken[source] = taken.get(source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_op4_base_secrets(spark, sf_dir, duck):
    """Counts of the base kinds, with the same patterns in DuckDB."""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    sql = f"""
    SELECT doc_id, len(list_filter(regexp_extract_all(t, '{assign}', 1), lambda x: length(x) >= 12)),
           len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)), len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16))
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    """
    compared(spark, sf_dir, duck, queries.op4_secrets, sql, ["doc_id", "n_assign", "n_access", "n_hex"])
