"""DuckDB SQL of the span operators, by the plain patterns: places come from the matches and the gaps between them."""

from __future__ import annotations

from granary.llm import pii, secrets


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(name: str, text: str, pattern: str, table: str = "d") -> str:
    """A view (r, s, a, b): matches of a pattern with their places, end exclusive."""
    p = _quoted(pattern)
    return f"""{name} AS (
  SELECT r, ms[i] AS s, a, a + length(ms[i]) AS b FROM (
    SELECT r, ms, i, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
    FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT r, regexp_extract_all({text}, {p}) AS ms, string_split(regexp_replace({text}, {p}, chr(1), 'g'), chr(1)) AS gs FROM {table})
      WHERE len(ms) > 0)))"""


def _joined(source: str, where: str = "true") -> str:
    return f"coalesce((SELECT string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) FROM {source} x WHERE x.r = d.r AND {where}), '')"


def _count(kind: str) -> str:
    return f"(SELECT count(*) FROM spans x WHERE x.r = d.r AND kind = '{kind}') AS n_{kind}"


_DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents)"
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _entropy(w: int) -> str:
    """The greatest entropy of a window of w characters of s."""
    return f"""list_max(list_transform(range(1, length(s) - {w} + 2), lambda i: -list_sum(list_transform(list_distinct(string_split(substr(s, i, {w}), '')),
      lambda c: len(list_filter(string_split(substr(s, i, {w}), ''), lambda x: x = c)) / {w}.0::DOUBLE * log2(len(list_filter(string_split(substr(s, i, {w}), ''), lambda x: x = c)) / {w}.0::DOUBLE)))))"""


def secrets_sql() -> str:
    fine = " OR ".join(f"regexp_matches(s, {_quoted(a)})" for a in secrets.ALLOWED)
    least = "CASE " + " ".join(f"WHEN regexp_matches(s, {_quoted(p)}) THEN {bits}::DOUBLE" for _, p, bits in secrets.CLASSES) + " ELSE 99.0::DOUBLE END"
    views = [
        _DOCS,
        _found("assign", "t", _ASSIGN),
        _found("access", "t", "AKIA[A-Z0-9]+"),
        _found("hexes", "t", "[0-9a-f]{24,}"),
        _found("candidates", "t", "[A-Za-z0-9+/_-]{20,}={0,2}"),
        f"""base AS (SELECT r, a, b, 0 AS rank, 'assign' AS kind FROM assign WHERE length(regexp_extract(s, {_quoted(_ASSIGN)}, 1)) >= 6
  UNION ALL SELECT r, a, b, 1, 'access' FROM access WHERE length(s) >= 20
  UNION ALL SELECT r, a, b, 2, 'hex' FROM hexes)""",
        f"""spans AS (SELECT * FROM base UNION ALL SELECT r, a, b, 3, 'entropy' FROM candidates c
  WHERE regexp_matches(rtrim(s, '='), '[0-9]') AND NOT ({fine}) AND {least} < 90 AND {_entropy(secrets.WINDOW)} >= {least}
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = c.r AND x.a < c.b AND c.a < x.b))""",
    ]
    return "WITH " + ",\n".join(views) + f"\nSELECT doc_id, {', '.join(_count(k) for k in secrets.KINDS)}, sha256({_joined('base')}) AS base_sha256, {_joined('spans')} AS spans FROM d"


_LUHN = """list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(g[length(g) + 1 - i] AS INTEGER)
  WHEN CAST(g[length(g) + 1 - i] AS INTEGER) > 4 THEN 2 * CAST(g[length(g) + 1 - i] AS INTEGER) - 9 ELSE 2 * CAST(g[length(g) + 1 - i] AS INTEGER) END)) % 10 = 0"""
_WORD = r"\p{L}[\p{L}\p{M}'-]{2,}"


def pii_sql() -> str:
    near = pii.NEAR
    views = [
        _DOCS,
        _found("emails", "t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        _found("ips", "t", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        _found("cards", "t", r"[0-9]([\x20-]?[0-9])+"),
        _found("phones", "t", r"\+[0-9][\x20().0-9-]+[0-9]"),
        f"""base AS (SELECT r, a, b, 0 AS rank, 'email' AS kind, s FROM emails
  UNION ALL SELECT r, a, b, 1, 'ip', s FROM ips WHERE len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
  UNION ALL SELECT r, a, b, 2, 'card', s FROM (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS g FROM cards) WHERE length(g) BETWEEN 14 AND 19 AND {_LUHN}
  UNION ALL SELECT r, a, b, 3, 'phone', s FROM phones WHERE length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)""",
        "entity_holders AS (SELECT * FROM d WHERE r IN (SELECT r FROM base))",
        _found("near_words", "t", _WORD, "entity_holders"),
        f"""sides AS (SELECT x.kind || ':' || lower(x.s) AS entity, d.t AS doc,
    coalesce((SELECT list(w.s ORDER BY w.a) FROM near_words w WHERE w.r = x.r AND w.b <= x.a), [])[-{near}:] AS l,
    coalesce((SELECT list(w.s ORDER BY w.a) FROM near_words w WHERE w.r = x.r AND w.a >= x.b), [])[1:{near}] AS rt
  FROM base x JOIN d ON x.r = d.r)""",
        """near_terms AS (SELECT entity, doc, l, rt, unnest(list_distinct(list_transform(list_concat(l, rt), lambda w: lower(w)))) AS term FROM sides)""",
        f"""pairs AS (SELECT entity, term, count(DISTINCT doc) AS net FROM near_terms GROUP BY entity, term
  HAVING count(DISTINCT struct_pack(l := l, rt := rt)) >= {pii.SUPPORT})""",
        f"""term_docs AS (SELECT term, count(DISTINCT doc) AS nt FROM (SELECT lower(t) AS doc, unnest(list_distinct(regexp_extract_all(lower(t), {_quoted(_WORD)}))) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY term)""",
        "entity_docs AS (SELECT entity, count(DISTINCT doc) AS ne FROM sides GROUP BY entity)",
        "total AS (SELECT CAST(count(DISTINCT t) AS DOUBLE) AS n FROM d)",
        f"""revealing AS (SELECT term FROM pairs JOIN entity_docs USING (entity) JOIN term_docs USING (term), total WHERE ne < n
  GROUP BY term HAVING max(log2(net * n / (CAST(ne AS DOUBLE) * nt)) / log2(n / ne)) >= {pii.GENERALISE})""",
        "holders AS (SELECT * FROM d WHERE EXISTS (SELECT 1 FROM revealing WHERE contains(lower(t), term)))",
        _found("all_words", "t", _WORD, "holders"),
        """spans AS (SELECT r, a, b, rank, kind FROM base UNION ALL SELECT r, a, b, 4, 'term' FROM all_words w WHERE lower(s) IN (SELECT term FROM revealing)
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = w.r AND x.a < w.b AND w.a < x.b))""",
    ]
    return "WITH " + ",\n".join(views) + f"\nSELECT doc_id, {', '.join(_count(k) for k in pii.KINDS)}, sha256({_joined('base')}) AS base_sha256, {_joined('spans')} AS spans FROM d"
