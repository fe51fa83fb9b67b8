"""Query of document fingerprints."""

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import read
from tessella.llm.fingerprints import BOUND, LENGTH_STEPS, LENGTH_WEIGHT, MIX, TRIPLETS, compare_with_edits


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


_VALUE = " UNION ALL ".join(
    f"SELECT doc_id, which, w{a} * 65536 + w{b} * 256 + w{c} + {k << 24} AS v FROM five"
    for k, (a, b, c) in enumerate(TRIPLETS)
)

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS MATERIALIZED (SELECT n.doc_id, n.next_id, n.t, left(n.t, length(n.t) - length(n.t) // 4) || left(d.t, length(n.t) // 4) AS changed
  FROM n JOIN d ON d.doc_id = n.next_id),
h AS (SELECT doc_id, 0 AS which, '0000' || hex(encode(t)) || '0000' AS h FROM e
  UNION ALL SELECT doc_id, 1, '0000' || hex(encode(changed)) || '0000' FROM e),
cut AS MATERIALIZED (SELECT doc_id, which, substr(h, 256 * j + 1, 264) AS h FROM (SELECT doc_id, which, h, unnest(range(0, (length(h) // 2 + 123) // 128)) AS j FROM h)),
w AS (SELECT doc_id, which, CAST('0x' || substr(h, 2 * i + 1, 10) AS UBIGINT) AS w FROM (SELECT doc_id, which, h, unnest(range(0, length(h) // 2 - 4)) AS i FROM cut)),
five AS MATERIALIZED (SELECT doc_id, which, {", ".join(f"(w >> {32 - 8 * i}) % 256 AS w{i}" for i in range(5))} FROM w),
v AS ({_VALUE}),
m AS (SELECT doc_id, which, (v * {MIX[0]}) % 4294967296 AS x FROM v),
b AS (SELECT doc_id, which, CAST(((xor(x, x >> 15) * {MIX[1]}) % 4294967296) >> 24 AS INTEGER) AS bucket FROM m),
found AS (SELECT doc_id, which, bucket, count(*) AS n FROM b GROUP BY ALL),
c AS MATERIALIZED (SELECT h.doc_id, h.which, s.bucket, coalesce(found.n, 0) AS n FROM h CROSS JOIN (SELECT unnest(range(0, 256)) AS bucket) s
  LEFT JOIN found ON found.doc_id = h.doc_id AND found.which = h.which AND found.bucket = s.bucket),
q AS (SELECT doc_id, which, list_sort(list(n)) AS s FROM c GROUP BY ALL),
code AS MATERIALIZED (SELECT c.doc_id, c.which, bucket, CAST(n > s[64] AS INTEGER) + CAST(n > s[128] AS INTEGER) + CAST(n > s[192] AS INTEGER) AS k
  FROM c JOIN q ON q.doc_id = c.doc_id AND q.which = c.which),
size AS (SELECT doc_id, which, length(h) // 2 - 4 AS n FROM h),
len AS MATERIALIZED (SELECT doc_id, which, CASE WHEN n = 0 THEN 0 ELSE least(255, 8 * length(bin(n)) + ((n << 3) >> (length(bin(n)) - 1)) % 8) END AS l FROM size),
quad AS (SELECT doc_id, which, bucket // 4 AS g, sum(k * CAST(pow(4, 3 - bucket % 4) AS INTEGER)) AS byte FROM code GROUP BY ALL),
print AS MATERIALIZED (SELECT doc_id, which, printf('%02x', l) || string_agg(printf('%02x', CAST(byte AS INTEGER)), '' ORDER BY g) AS f
  FROM quad JOIN len USING (doc_id, which) GROUP BY doc_id, which, l),
pairs AS (SELECT doc_id, 0 AS kind, doc_id AS other, 1 AS other_which FROM e UNION ALL SELECT doc_id, 1, next_id, 0 FROM e),
body AS (SELECT p.doc_id, p.kind, sum(abs(x.k - y.k)) AS n FROM pairs p
  JOIN code x ON x.doc_id = p.doc_id AND x.which = 0
  JOIN code y ON y.doc_id = p.other AND y.which = p.other_which AND y.bucket = x.bucket GROUP BY p.doc_id, p.kind),
near AS (SELECT body.doc_id, body.kind, 1 - least({BOUND}, n + {LENGTH_WEIGHT} * least({LENGTH_STEPS}, abs(x.l - y.l))) / {BOUND}.0::DOUBLE AS v
  FROM body JOIN pairs p ON p.doc_id = body.doc_id AND p.kind = body.kind
  JOIN len x ON x.doc_id = p.doc_id AND x.which = 0 JOIN len y ON y.doc_id = p.other AND y.which = p.other_which)
SELECT e.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(changed) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  x.v AS near_edited, y.v AS near_next
FROM e JOIN print a ON a.doc_id = e.doc_id AND a.which = 0 JOIN print b ON b.doc_id = e.doc_id AND b.which = 1
JOIN near x ON x.doc_id = e.doc_id AND x.kind = 0 JOIN near y ON y.doc_id = e.doc_id AND y.kind = 1
"""
