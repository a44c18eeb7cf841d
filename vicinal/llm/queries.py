"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm.alignment import op12_alignment
from vicinal.llm.flatgraph import op4_vectors
from vicinal.llm.minhash import op5_minhash
from vicinal.llm.mixing import op6_mixing
from vicinal.llm.pieces import op7_sentencepiece
from vicinal.llm.positive import op13_quality
from vicinal.llm.quality import op2_quality
from vicinal.llm.quotes import op9_quotes
from vicinal.llm.repair import OP11_SQL, op11_repair
from vicinal.llm.revisits import OP1_SQL, op1_revisits
from vicinal.llm.secrets import op10_secrets
from vicinal.llm.suffixes import op3_suffixes
from vicinal.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisits": op1_revisits,
    "op2_quality": op2_quality,
    "op3_suffixes": op3_suffixes,
    "op4_vectors": op4_vectors,
    "op5_minhash": op5_minhash,
    "op6_mixing": op6_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_quotes": op9_quotes,
    "op10_secrets": op10_secrets,
    "op11_repair": op11_repair,
    "op12_alignment": op12_alignment,
    "op13_quality": op13_quality,
}

SQL: dict[str, str] = {"op1_revisits": OP1_SQL, "op11_repair": OP11_SQL}

SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, CAST(source IS NULL AS INT) AS none, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT src, none, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1, 2),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY none, encode(src)) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
r AS (SELECT *, source_size / weight AS ratio FROM w),
u AS (SELECT *, CAST(sum(source_size) OVER () * 150 - 200 * (sum(source_size) OVER o - source_size) AS BIGINT) AS rest,
             CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS lft
      FROM r WINDOW o AS (ORDER BY ratio, none, encode(src) ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, rest * weight >= 200 * source_size * lft AS capped FROM u),
f AS (SELECT rest AS rest1, lft AS lft1 FROM c WHERE NOT capped ORDER BY ratio, none, encode(src) LIMIT 1),
t AS (SELECT src, none, source_size, CASE WHEN capped THEN CAST(source_size * 2 AS DOUBLE) ELSE CAST(weight * rest1 AS DOUBLE) / CAST(100 * lft1 AS DOUBLE) END AS target
      FROM c LEFT JOIN f ON true),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST(('0x' || substr(md5('mix-1:' || CAST(none AS VARCHAR) || ':' || src), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS off,
             row_number() OVER (PARTITION BY src, none ORDER BY CAST(floor(8 * log2(size + 1)) AS INT), substr(h, 1, 3), h, size) AS place
      FROM d JOIN t USING (src, none))
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(place * rate + off) - floor((place - 1) * rate + off)) AS BIGINT) AS taken FROM p
"""
