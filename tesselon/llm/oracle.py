"""DuckDB SQL for the queries that SQL can express."""

OP2 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_WEIGHT = {
    "domain": "CASE domain WHEN 'src0' THEN 2.0 WHEN 'src1' THEN 3.0 ELSE 1.0 END",
    "language": "CASE language WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 ELSE 1.0 END",
    "source": "CASE source WHEN 'src10' THEN 2.0 ELSE 1.0 END",
}


def _share(name: str, nodes: str, parent: str, keys: str) -> str:
    """Deal the pool of each parent to its children by weight, none above its supply."""
    return f"""
{name}_ranked AS (
  SELECT *, coalesce(sum(supply) OVER (PARTITION BY {parent} ORDER BY supply / weight, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
         sum(weight) OVER (PARTITION BY {parent} ORDER BY supply / weight, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM ({nodes})),
{name}_full AS (SELECT *, supply * onward <= (pool - before) * weight AS is_full FROM {name}_ranked),
{name} AS (
  SELECT *, CASE WHEN is_full THEN supply ELSE
    (pool - coalesce(sum(supply) FILTER (is_full) OVER (PARTITION BY {parent}), 0.0::DOUBLE)) * weight
      / sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parent}) END AS budget
  FROM {name}_full)"""


OP6 = f"""
WITH docs AS (
  SELECT doc_id, substring(coalesce(source, ''), 1, 4) AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source,
         CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * 2 AS DOUBLE) AS supply FROM docs GROUP BY ALL),
{_share("d", f"SELECT domain, 1 AS root, sum(supply) AS supply, 0.6::DOUBLE * CAST(sum(sum(tokens)) OVER () AS DOUBLE) AS pool, ({_WEIGHT['domain']})::DOUBLE AS weight FROM leaves GROUP BY domain", "root", "domain")},
{_share("l", f"SELECT domain, language, sum(leaves.supply) AS supply, any_value(d.budget) AS pool, ({_WEIGHT['language']})::DOUBLE AS weight FROM leaves JOIN d USING (domain) GROUP BY domain, language", "domain", "domain, language")},
{_share("s", f"SELECT domain, language, source, tokens, leaves.supply, l.budget AS pool, ({_WEIGHT['source']})::DOUBLE AS weight FROM leaves JOIN l USING (domain, language)", "domain, language", "domain, language, source")},
plan AS (SELECT domain, language, source, CAST(floor(budget) AS BIGINT) AS take, tokens AS leaf_tokens FROM s),
passes AS (
  SELECT docs.*, epoch, take, leaf_tokens, md5('7:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM docs JOIN plan USING (domain, language, source), range(0, 2) AS passed(epoch)),
upto AS (
  SELECT *, epoch * leaf_tokens + sum(tokens) OVER (PARTITION BY domain, language, source, epoch ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent
  FROM passes)
SELECT doc_id, epoch, domain, language, source, tokens
FROM upto WHERE spent <= take AND (epoch = 0 OR leaf_tokens > 0)
"""

OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'))
          + length(replace(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) + 14 AS size
  FROM rows),
upto AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS sizes,
         lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS ends
  FROM shown)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(sizes) FILTER (role = 'assistant' OR ends) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id
"""

SQL = {"op2_exact_dedup": OP2, "op6_mixing": OP6, "op9_chat_format": OP9}
