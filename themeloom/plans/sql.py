"""Shared parts of the oracle SQL: named common table expressions and what each needs."""

from __future__ import annotations

import re

TOKEN = r"[\p{L}\p{N}_]{2,}"

PARTS = {
    "tok": f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents",
    "dtm0": "SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
    "voc": "SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM dtm0 GROUP BY term HAVING count(*) >= 10",
    "dtm": "SELECT doc_id, term, tf FROM dtm0 JOIN voc USING (term)",
    "lab": "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS topic_id FROM documents",
    "tops": "SELECT DISTINCT topic_id FROM lab",
    "tt": "SELECT topic_id, term, CAST(sum(tf) AS BIGINT) AS tf FROM dtm JOIN lab USING (doc_id) GROUP BY ALL",
    "fulltt": "SELECT t.topic_id, v.term, coalesce(tt.tf, 0) AS tf FROM voc v CROSS JOIN tops t LEFT JOIN tt ON tt.topic_id = t.topic_id AND tt.term = v.term",
    "raw": "SELECT doc_id, CAST(k AS INTEGER) AS topic_id, CAST(instr('0123456789abcdef', substr(md5(doc_id || '#' || k), 1, 1)) AS DOUBLE) AS w FROM documents, range(4) AS r(k)",
    "soft": "SELECT doc_id, topic_id, w / sum(w) OVER (PARTITION BY doc_id) AS weight FROM raw",
    "tv": "SELECT term, list_transform(range(1, 33), lambda i: instr('0123456789abcdef', substr(md5(term), i, 1)) * 2 - 17) AS v FROM voc",
    "tvx": "SELECT term, unnest(range(1, 33)) AS i, unnest(v) AS x FROM tv",
    "dvx": "SELECT doc_id, i, CAST(sum(tf * x) AS BIGINT) AS x FROM dtm JOIN tvx USING (term) GROUP BY ALL",
    "dv": "SELECT doc_id, list(x ORDER BY i) AS v FROM dvx GROUP BY doc_id",
    "cw": "SELECT topic_id, term, tf * ln(1 + (sum(tf) OVER () / CAST((SELECT count(*) FROM tops) AS DOUBLE)) / sum(tf) OVER (PARTITION BY term)) AS weight FROM tt",
    "cwr": "SELECT topic_id, term, round(weight, 6) + 0.0 AS weight FROM cw",
    "emx": "SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "cen": "SELECT label AS topic_id, i, avg(x) AS x FROM emx GROUP BY ALL",
    "docts": "SELECT doc_id, (SELECT epoch_us(min(ts)) FROM events) + doc_id * 3600000000 AS us FROM documents",
    "binned": "SELECT doc_id, CAST(least(floor((us - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin FROM docts, (SELECT min(us) AS lo, max(us) + 1 AS hi FROM docts)",
}


def with_(body: str, **more: str) -> str:
    """body with the common table expressions that it names, and those that they name, before it."""
    known = PARTS | more
    order: list[str] = []
    open_: set[str] = set()

    def named(sql: str) -> tuple[list[str], list[str]]:
        """Names after FROM or JOIN, which are tables; and other words that may be tables in a list, or columns."""
        sure = [n for n in re.findall(r"(?:FROM|JOIN)\s+\(*([a-z]\w*)", sql) if n in known]
        return sure, [n for n in re.findall(r",\s*([a-z]\w*)\b(?!\s*(?:\.|\())", sql) if n in known]

    def need(name: str) -> bool:
        if name in order or name in open_:
            return name in order
        open_.add(name)
        sure, perhaps = named(known[name])
        good = all([need(n) for n in sure if n != name])
        if good:
            for n in perhaps:
                need(n)
            order.append(name)
        open_.discard(name)
        return good

    for group in named(body):
        for n in group:
            need(n)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + " " + body if order else body


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
