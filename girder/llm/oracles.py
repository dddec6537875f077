"""SQL that states the results of the queries, run by another engine on the same tables."""

from __future__ import annotations

from girder.llm.licenses import TEMPLATES

ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = "[^\\x20\\x09-\\x0D]+"


def mixture_sql(docs: str = "documents", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: int = 2, seed: int = 17) -> str:
    listed = ", ".join(map(str, weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM {docs}
), leaned AS (
  SELECT *, floor(100000 / (size + 100))::BIGINT AS lean,
         (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM sized
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * lean)::BIGINT AS leaning,
         ([{listed}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight
  FROM leaned GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () * {share}::DOUBLE - coalesce(sum(source_size * {ceiling}) OVER (
              ORDER BY source_size * {ceiling} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size * {ceiling} / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM totals
), targets AS (
  SELECT source, source_size, leaning, least(source_size * {ceiling}::DOUBLE,
         coalesce(max(CASE WHEN source_size * {ceiling} / weight > level THEN level END) OVER () * weight, source_size * {ceiling}::DOUBLE)) AS target
  FROM levels
), parts AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets
), joined AS (
  SELECT l.doc_id, l.size, l.draw, l.lean, p.*, p.ratio - p.whole AS part, p.target - p.whole * p.source_size AS needed
  FROM leaned l JOIN parts p ON l.source IS NOT DISTINCT FROM p.source
), chances AS (
  SELECT *, CASE WHEN part > 0 AND size > 0 THEN part + part * (1.0::DOUBLE - part) * (lean - leaning::DOUBLE / source_size) / 1000.0::DOUBLE END AS chance
  FROM joined
), ranked AS (
  SELECT *, draw * (1.0::DOUBLE - chance) / ((1.0::DOUBLE - draw) * chance) AS pareto FROM chances
), summed AS (
  SELECT *, CASE WHEN chance IS NOT NULL THEN sum(size) OVER (
      PARTITION BY source, chance IS NULL ORDER BY pareto, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto
  FROM ranked
), decided AS (
  SELECT *, whole + CASE WHEN chance IS NOT NULL AND upto - size / 2 <= needed THEN 1 ELSE 0 END AS taken_copies FROM summed
)
SELECT doc_id, size, source_size, target, (taken_copies * size)::BIGINT AS taken, taken_copies::INTEGER AS copies FROM decided
"""


def lines_sql(docs: str = "documents", min_docs: int = 10) -> str:
    return f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM {docs}
), keyed AS (
  SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS line_key FROM split
), shared AS (
  SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= {min_docs}
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(s.line_key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE s.line_key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.line_key = s.line_key GROUP BY doc_id
"""


ORACLES["op2_source_mixture"] = mixture_sql()
ORACLES["op9_line_dedup"] = lines_sql()


def containment_sql(docs: str = "documents", items: str = "benchmark", percent: int = 80, size: int = 5) -> str:
    """Brute force over exact shingles: every item against every document that shares one."""

    def tokens(name: str, key: str) -> str:
        joined = " || ' ' || ".join(["words[place]"] + [f"words[place + {k}]" for k in range(1, size)])
        return f"""
  SELECT DISTINCT {key}, CASE WHEN len(words) < {size} THEN array_to_string(words, ' ') ELSE {joined} END AS token
  FROM (SELECT {key}, words, unnest(range(1, greatest(len(words) - {size - 1}, 1) + 1)) AS place
        FROM (SELECT {key}, regexp_extract_all(lower(text), '{WORD}') AS words FROM {name} WHERE text IS NOT NULL AND {key} IS NOT NULL) WHERE len(words) > 0)"""

    return f"""
WITH d AS ({tokens(docs, 'doc_id')}), i AS ({tokens(items, 'item_id')}),
sizes AS (SELECT item_id, count(*)::BIGINT AS item_size FROM i GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM i JOIN d USING (token) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_size, shared, shared / item_size AS containment
FROM shared JOIN sizes USING (item_id) WHERE shared * 100 >= item_size * {percent}
"""


ORACLES["op10_benchmark_decontamination"] = containment_sql()


def license_sql(docs: str = "documents", percent: int = 80) -> str:
    values = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES.items())
    found = containment_sql(docs, "templates", percent).replace("WITH d AS", f"WITH templates(item_id, text) AS (VALUES {values}), d AS", 1)
    return f"SELECT doc_id, item_id AS license, item_size AS template_size, shared, containment FROM ({found})"


ORACLES["op7_license_scan"] = license_sql()


def clusters_sql(vectors: str = "embeddings", k: int = 40, size: int = 64, rounds: int = 5, seed: int = 2, scale: int = 256) -> str:
    """The rounds one after the other, every vector against every centroid."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM {vectors} WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c
  FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT place, min(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT * {k} + cluster) AS packed
  FROM kept CROSS JOIN c{i} GROUP BY place
)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY spot) AS mean
  FROM (SELECT packed % {k} AS cluster, spot, sum(v[spot])::HUGEINT AS total, count(*)::HUGEINT AS n
        FROM a{i} JOIN kept USING (place) CROSS JOIN range(1, {size + 1}) AS g(spot) GROUP BY ALL)
  GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(list_transform(m.mean, lambda x: x::BIGINT), c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON c.cluster = m.cluster
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, (packed % {k})::INTEGER AS cluster, (packed // {k})::BIGINT AS distance,
       (sum(packed // {k}) OVER (PARTITION BY packed % {k}))::BIGINT AS cluster_inertia, (sum(packed // {k}) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (place) JOIN c{rounds} ON packed % {k} = cluster
"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranking_sql(docs: str = "documents", items: str = "benchmark", top: int = 10) -> str:
    """Every query term against every document that holds it."""

    def terms(text: str) -> str:
        return f"unnest(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TERM}'))"

    return f"""
WITH held AS MATERIALIZED (
  SELECT place, doc_id, term, count(*)::BIGINT AS tf
  FROM (SELECT place, doc_id, {terms('text')} AS term FROM (SELECT row_number() OVER () AS place, doc_id, text FROM {docs}))
  GROUP BY place, doc_id, term
), sizes AS (SELECT place, sum(tf)::BIGINT AS n FROM held GROUP BY place),
totals AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS length FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), totals
), parts AS (
  SELECT place, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // length))) AS part
  FROM held JOIN weights USING (term) JOIN sizes USING (place), totals
), wanted AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, {terms('text')} AS term FROM (SELECT DISTINCT item_id, text FROM {items} WHERE item_id IS NOT NULL))
  GROUP BY item_id, term
), scored AS (
  SELECT item_id, place, doc_id, sum(times * part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, place, doc_id
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {top}
"""


ORACLES["op11_centroid_clusters"] = clusters_sql()
ORACLES["op12_lexical_search"] = ranking_sql()
