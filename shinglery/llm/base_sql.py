"""The fixed columns of the scans as SQL, for the queries that show these columns alone.

A pattern's matches and the texts between them alternate, so that sums of their lengths give positions.
"""

from __future__ import annotations

from shinglery.llm import licences, pii, secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One CRC-32 step for each bit, the lowest first.
STEP = "lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def licence_sql() -> str:
    starts = []
    for phrase, label in licences.BASE.items():
        words = phrase.split()
        here = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words, 1))
        starts.append(f"list_transform(list_filter(range(len(ws)), lambda i: {here}), lambda i: {{'at': i, 'label': '{label}'}})")
    found = starts[0]
    for more in starts[1:]:
        found = f"list_concat({found}, {more})"
    return f"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
places AS (SELECT doc_id, len(ws) AS n_words, {found} AS p FROM words)
SELECT doc_id, n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels FROM places"""


def media_sql() -> str:
    byte = "('0x' || substr(h, 2 * i + 1, 2))::UBIGINT"
    bits = f"flatten(list_transform(range(64), lambda i: list_transform(range(8), lambda j: ({byte} >> j) & 1)))"
    return f"""WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
filled AS (SELECT doc_id, n, b || unhex(repeat('00', CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END)) AS payload FROM docs),
tails AS (SELECT doc_id, n, payload, substr(hex(payload), 2 * octet_length(payload) - 127) AS h FROM filled)
SELECT doc_id, n AS n_bytes, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_sha256, xor(list_reduce(list_prepend(4294967295::UBIGINT, {bits}), {STEP}), 4294967295::UBIGINT)::BIGINT AS tail_crc32 FROM tails"""


def spans(kind: str, order: int, pattern: str, good: str, group: int = 0) -> str:
    """Rows (r, kind, start, stop) of the matches of a pattern of which `good` holds; m is a match, or its group."""
    p = quoted(pattern)
    return f"""SELECT r, '{kind}' AS kind, {order} AS ord, begun AS start, begun + length(x) AS stop FROM (SELECT r, x, m, (list_sum(list_transform(gaps[:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda g: length(g))), 0))::BIGINT AS begun
FROM (SELECT r, ms, gaps, unnest(ms) AS x, unnest(gs) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT r, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS gs, regexp_split_to_array(t, {p}) AS gaps FROM docs WHERE regexp_matches(t, {p})))) WHERE {good}"""


def digested(kinds: tuple[str, ...], found: list[str], order: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT * FROM ({') UNION ALL SELECT * FROM ('.join(found)})),
by_row AS (SELECT r, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}) AS all_spans FROM found GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, sha256(coalesce(all_spans, '')) AS base_sha256 FROM docs LEFT JOIN by_row ON docs.r = by_row.r"""


def secret_sql() -> str:
    keys = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    assign = keys + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [
        spans("assign", 0, assign, f"length(m) >= {secrets.LEAST['assign']}", 1),
        spans("access", 1, "AKIA[A-Z0-9]+", f"length(m) >= {secrets.LEAST['access']}"),
        spans("hex", 2, "[0-9a-f]+", "length(m) >= 24"),
    ]
    return digested(secrets.BASE, found, "start, ord")


def personal_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = "list_transform(range(length(d)), lambda i: CASE WHEN (length(d) - 1 - i) % 2 = 1 THEN 2 * d[i + 1]::INT - CASE WHEN d[i + 1]::INT > 4 THEN 9 ELSE 0 END ELSE d[i + 1]::INT END)"
    luhn = f"list_sum({doubled.replace('d[', 'q[').replace('length(d)', 'length(q)')}) % 10 = 0"
    part = "list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE coalesce(try_cast(ltrim(p, '0') AS INT), 0) END)) <= 255"
    card = f"length({digits}) BETWEEN 13 AND 19 AND list_filter([{digits}], lambda q: {luhn}) <> []"
    found = [
        spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        spans("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", part),
        spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", card),
        spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    ]
    return digested(pii.KINDS, found, "ord, start")
