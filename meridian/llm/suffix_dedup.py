"""Suffix-array dedup: bytes covered by a long string that also starts earlier.

See ``repeats`` for the method: sampled suffixes, range-partitioned by leading
bytes and sorted in buckets; where a suffix has several contexts, the suffixes of all
its windows are sorted on their bytes by multikey quicksort, eight at a time.

Defined results: a null text is empty; texts shorter than the limit are kept;
rows with a null doc_id are kept whole and remove nothing; rows that repeat a
doc_id with the same text have equal results; rows that repeat it with another text
are documents of their own, none of them earlier than the others; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import Rule, compare_suffixes, without_repeats

LENGTH = 100
#: Bytes of the grams that choose the sampled suffixes.
GRAM = 48


def duplicate_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (the remaining bytes) of every row."""
    if length < 8:
        raise ValueError("strings of under eight bytes are not looked for")
    rule = Rule("bytes", length, max(min(gram, max(8, length // 2)), length - 1000), True, compare_suffixes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")

    def finish(text: bytes, gone) -> tuple:
        if gone is None:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest(), *([text] if keep else [])
        data = np.frombuffer(text, dtype=np.uint8)
        mark = gone(len(data))
        kept = data[~mark].tobytes()
        edges = int(np.count_nonzero(mark[1:] & ~mark[:-1]) + (len(mark) > 0 and mark[0]))
        return len(data), int(mark.sum()), edges, hashlib.sha256(kept).hexdigest(), *([kept] if keep else [])

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    return without_repeats(rows, rule, finish, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    return duplicate_bytes(table(spark, sf_dir, "documents"), keep=False)


OP3_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS s
      FROM d, LATERAL (SELECT unnest(range(0, CAST(len(h) // 2 - 99 AS BIGINT))) AS i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 0 ELSE 1 END AS new_ FROM f),
r AS (SELECT doc_id, i, sum(new_) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS b FROM spans
         UNION ALL SELECT doc_id, 0, min(lo) FROM spans GROUP BY doc_id),
kept AS (SELECT d.doc_id, string_agg(substr(d.h, CAST(2 * g.a + 1 AS BIGINT), CAST(2 * (coalesce(g.b, len(d.h) // 2) - g.a) AS BIGINT)), '' ORDER BY g.a) AS k
         FROM d JOIN gaps g USING (doc_id) GROUP BY d.doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.k, d.h))) AS kept_sha256
FROM d LEFT JOIN sums s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
